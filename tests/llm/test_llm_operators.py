import collections
import hashlib
import html
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from bedwise.llm import common, decontaminate, embedding_dedup, html_extract, minhash_dedup, mixing, pii, queries, suffix_dedup, token_store, toxicity, url_filter
from bedwise.llm.common import components, ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keys string, s string, size int, comp int"


@pytest.fixture(scope="module", autouse=True)
def package(spark):
    ship(spark)


def docs_of(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, "en", src, None if t is None else len(t), "k", "s", 1, 2) for i, t, src in rows], DOCS)


def words(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, repeats inside a text, nulls, empty and very long texts, repeated ids."""
    rng = random.Random(5)
    base, passage = words(rng, 120), words(rng, 60)
    rows = [(1, None, "a"), (2, "", "a"), (3, "   \n", None), (4, "one two", "b"), (5, "one two", "b"), (6, base, "a"), (7, base, "a"), (7, base, "a")]
    for k in range(12):
        text = base.split()
        for _ in range(k // 3):
            text[rng.randrange(len(text))] = "changed"
        rows.append((20 + k, " ".join(text), "a"))
    for k in range(6):
        rows.append((40 + k, words(rng, 30) + " " + passage + " " + words(rng, 20), rng.choice("abc")))
    line = words(rng, 45)
    rows += [(50, (line + "\n") * 4, "c"), (51, words(rng, 4000), "c"), (52, "é" * 350 + words(rng, 50), None), (53, "x" * 700, "c"), (None, words(rng, 50), "b"), (None, base, "b")]
    return rows


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 201), (201, 202), (202, 200), (7, 7), (3, 2)]
    found = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    w = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_equal_all_pairs(spark, corpus, percent):
    rows = [r for r in corpus]
    out = minhash_dedup.near_duplicates(docs_of(spark, rows), percent).collect()
    assert len(out) == len(rows)
    parent = {i: i for i, *_ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t)) for i, t, _ in rows]
    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and x and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    sizes = collections.Counter((i, len(s)) for i, s in sets)
    assert collections.Counter((r.doc_id, r.n_shingles) for r in out) == sizes
    for r in out:
        assert (r.component_id, r.kept) == ((None, True) if r.doc_id is None else (find(r.doc_id), find(r.doc_id) == r.doc_id))


def test_hot_group_is_joined_inside_tasks(spark, monkeypatch):
    """Near copies of near copies: no centre links all, blocks are split, the result is that of all pairs."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 8)
    rng = random.Random(2)
    text, rows = words(rng, 100).split(), []
    for i in range(40):
        rows.append((i, " ".join(text), "a"))
        for k in range(3):
            text[(i * 11 + k) % 100] = f"w{i}{k}"
    out = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(docs_of(spark, rows), 75).collect()}
    sets = [shingles(t) for _, t, _ in rows]
    comp = list(range(40))
    for a in range(40):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                comp = [new if c == old else c for c in comp]
    assert out == dict(enumerate(comp))


def test_odd_sketch_limit_keeps_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(50):
        common = rng.integers(1, 2**63, 170).astype(np.uint64)
        sets = [np.concatenate([common, rng.integers(1, 2**63, 15).astype(np.uint64)]) for _ in range(2)]
        mins = minhash_dedup.min_hashes(np.concatenate(sets), np.array([0, 185, 370]))
        a, b = minhash_dedup.odd_sketches(mins).view(np.uint64)
        lost += int(np.bitwise_count(a ^ b).sum()) > minhash_dedup.sketch_limit(85)
    assert lost == 0


def test_suffix_array_by_grouping():
    rng = random.Random(1)
    for _ in range(400):
        text = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))] + [0]
        assert suffix_dedup.suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def expected_cut(rows):
    data = [(t or "").encode() for _, t, _ in rows]
    seen = collections.Counter(b[i:i + 200] for b in data for i in range(len(b) - 199))
    out = collections.Counter()
    for (doc, *_), b in zip(rows, data):
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = b"\1" * 200
        spans = len(re.findall(b"\1+", bytes(gone)))
        out[(doc, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())] += 1
    return out


@pytest.mark.parametrize("large", [20_000, 3])
def test_passages_equal_brute_force(spark, corpus, monkeypatch, large):
    """Also where every group counts as too large to be gathered in one task."""
    monkeypatch.setattr(suffix_dedup, "LARGE", large)
    out = suffix_dedup.without_repeats(docs_of(spark, corpus)).drop("kept").collect()
    assert collections.Counter(map(tuple, out)) == expected_cut(corpus)


def test_contamination_equals_brute_force(spark, corpus):
    rng = random.Random(3)
    texts = [t for _, t, _ in corpus if t]
    items = [(1, " ".join(texts[3].split()[5:40])), (2, "one two"), (3, None), (4, "..."), (5, words(rng, 20)), (None, " ".join(texts[3].split()[50:70])), (6, "ONE, two"), (7, "changed")]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, window int")
    out = decontaminate.contamination(docs_of(spark, corpus), table).drop("tid").collect()

    def split(t):
        return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").translate({c: c + 32 for c in range(65, 91)}).encode())

    wins = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(0, len(w) - 13) + 1 if w else 0):
            wins[tuple(w[k:k + 13])].add(i)
    want = collections.Counter()
    for doc, t, _ in corpus:
        w, hit, found = split(t), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= {str(i) for i in wins[tuple(w[k:k + n])] if i is not None}
        want[(doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))] += 1
    assert collections.Counter(map(tuple, out)) == want


def test_mix_meets_targets_and_caps(spark, corpus):
    rows = [(i, t, s) for i, t, s in corpus] + [(1000 + k, "w " * 400, "big") for k in range(30)]
    out = mixing.mixture(docs_of(spark, rows)).collect()
    assert len(out) == len(rows)
    total, taken = sum(r["size"] for r in out), collections.Counter()
    source = {(i, len((t or "").split())): s for i, t, s in rows}
    targets = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"]
        s = source[(r.doc_id, r["size"])]
        taken[s] += r.taken
        targets[s] = r.target
        assert r.target <= 3 * r.source_size + 1e-9
    assert math.isclose(sum(targets.values()), total, rel_tol=1e-12)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= max(3, 0.02 * t), (s, taken[s], t)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mixture(docs_of(spark, rows).repartition(7)).collect()))


def test_mix_shards_hold_their_quotas(spark):
    """Documents of one word: a shard is the documents that it takes first, and each takes its quota of blocks."""
    docs = docs_of(spark, [(k, f"w{k}", "ab"[k % 2]) for k in range(400)])
    sizes = spark.createDataFrame([("a", 200), ("b", 200)], "source string, size long")
    quota = {(r["source"], r["shard"]): r["quota"] * r["block"] for r in mixing.block_quotas(mixing.source_targets(sizes)).collect()}
    taken = mixing.mixture(docs).join(docs.select("doc_id", "source"), "doc_id").where("taken > 0")
    found = {(r["source"], r["shard"]): r["count"] for r in taken.groupBy("source", "shard").count().collect()}
    left = {"a": 200, "b": 200}  # the later shards of a source that is taken more than once take documents again
    for (source, shard), n in sorted(quota.items()):
        first = min(n, left[source])
        left[source] -= first
        assert found.get((source, shard), 0) == first
    assert mixing.mixture(docs).where("taken = 0 AND shard IS NOT NULL").count() == 0


def test_toxicity_with_few_labels(spark):
    """Labels of both classes in one fold only, of one class, and of one row each."""
    docs = docs_of(spark, [(k, f"text number {k} you fool", "a") for k in range(200)])
    fold = {r["doc_id"]: r["f"] for r in docs.where(toxicity.remainder(F.col("doc_id")) != 2).select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(toxicity.FOLDS)).alias("f")).collect()}
    same = [i for i, f in sorted(fold.items()) if f == 0][:4]
    for ids, share in ((same, 0.5), (same[:1], 0.0), (same[1:2], 1.0)):
        labels = spark.createDataFrame([(i, 1, same.index(i) % 2) for i in ids], "doc_id long, quality int, toxic int")
        assert {r["score"] for r in toxicity.train(docs, labels).score(docs).collect()} == {share}
    some = [i for f in range(toxicity.FOLDS) for i in [j for j, g in sorted(fold.items()) if g == f][:2]]
    labels = spark.createDataFrame([(i, 1, k % 2) for k, i in enumerate(some)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.train(docs, labels).score(docs).collect())


def test_mixed_rows_hold_the_words_taken(spark, corpus):
    docs = docs_of(spark, corpus)
    plan, out = mixing.mixture(docs), mixing.mixed(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    count = lambda df: {r[0]: r[1] for r in df.collect()}
    made = out.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).where("n > 0")
    assert count(made) == count(plan.groupBy("doc_id").agg(F.sum("taken").alias("n")).where("n > 0"))
    assert out.where("n_chars <> length(text)").count() == 0


def test_quotas_are_whole_and_follow_the_highest_quotients(spark):
    sizes = [("a", 700), ("b", 200), ("c", 90), ("d", 5), (None, 5)]
    targets = mixing.source_targets(spark.createDataFrame(sizes, "source string, size long"))
    quota = mixing.block_quotas(targets, shards=4).collect()
    assert all(q.quota >= 0 for q in quota)
    t = {r.source: r.target for r in targets.collect()}
    seats = sum(q.quota for q in quota)
    won = collections.Counter(s for _, s in sorted(((-x / (2 * i + 1), str(s)) for s, x in t.items() for i in range(1100)))[:seats])
    assert {str(s): sum(q.quota for q in quota if q.source == s) for s in t} == {str(s): won[str(s)] for s in t}


def test_token_files_round_trip(spark, corpus, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    extra = [(60, "Don't STOP <|endoftext|> naïve ÀÉ ×÷    é \x1c 'll 12,5%%%", "a"), (61, "İ ß Σας", "a")]
    rows = corpus + extra
    out = token_store.token_table(docs_of(spark, rows), path, str(tmp_path / "tokens")).collect()
    tok, start, want = Tokenizer.from_file(path), 0, []
    for doc, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == want


def test_pieces_have_the_ids_of_the_library(monkeypatch):
    """Contractions, digits, letters of other scripts, odd white space, special tokens, and texts cut at white space."""
    encoder = token_store.WordEncoder(queries.tokenizer_path())
    rng = np.random.default_rng(8)
    signs = np.array(list("abZ019 '\"sStTrevmlLd.,!<|>-_\t\n\x0b\x1c\x85\xa0\u00e9\u00c9\u00df\u00d7\u00f7\u015f\u0130\u03a3\u03c2\u0301\u200b\u00b2\u00aa\u4e2d"))
    texts = ["".join(rng.choice(signs[:k], rng.integers(0, 60))) for k in (26, len(signs)) for _ in range(2000)]
    texts += ["", "it's IT'S 'TIS \"'s we'll", "a<|endoftext|>b <|ENDOFTEXT|>", "'" * 50]
    want = encoder._encode(texts)
    assert encoder.encode(texts) == want
    monkeypatch.setattr(token_store, "RUN_CHARS", 50)
    monkeypatch.setattr(token_store, "CACHE_PIECES", 100)
    monkeypatch.setattr(token_store, "CACHE_WORDS", 100)
    long = [" ".join(texts[-300:]), "", "\u0301" + " ".join(texts[:300])]
    assert encoder.encode(long) == encoder._encode(long) and encoder.encode(texts) == want


def test_known_pieces_take_few_bytes():
    """What the encoder keeps of short pieces is arrays, not an object or two for each."""
    encoder = token_store.WordEncoder(queries.tokenizer_path())
    pieces = ["".join("abcdefghij"[int(d)] for d in f"{i * 37:06d}") for i in range(20_000)]
    tracemalloc.start()
    try:
        encoder.encode([" ".join(pieces)])
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert kept < 80 * len(pieces)
    assert encoder.encode(pieces[:50]) == encoder._encode(pieces[:50])


def test_freed_memory_leaves_the_worker():
    def held():
        return int(re.search(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1])

    small = [bytes(60_000) for _ in range(2000)]
    last = bytes(60_000)  # without a trim, what stands before it stays
    full = held()
    del small
    common.give_back()
    assert full - held() > 80_000 and last


def test_later_rounds_count_every_pair_that_is_frequent():
    """The grammar of a row is that of counting all pairs anew each round: after the last one, none is frequent."""
    rng = np.random.default_rng(11)
    for _ in range(40):
        ids = np.repeat(rng.integers(0, rng.integers(1, 40), rng.integers(1, 1500)), rng.integers(1, 6)).astype("<u4")
        shard = token_store.Shard(token_store.pack([1], [len(ids)], ids, 50))
        assert (shard.ids() == ids).all()
        assert token_store.compress(shard.seq.astype("<u4"), 50 + len(shard.left))[0] == []


def test_grammar_decodes_any_range():
    rng = np.random.default_rng(1)
    ids = np.concatenate([rng.zipf(1.3, 30_000) % 700, np.full(500, 9), np.tile([1, 2, 3], 300)]).astype("<u4")
    shard = token_store.Shard(token_store.pack([5, None, 7], [10_000, 1, len(ids) - 10_001], ids, 1000))
    assert (shard.ids() == ids).all() and len(shard.seq) < len(ids) and len(shard.left) == sum(shard.rounds)
    for a, b in [(0, 1), (777, 12_345), (10_000, 10_001), (len(ids) - 3, len(ids))]:
        assert (shard.between(a, b) == ids[a:b]).all()
    assert (shard.document(1) == ids[10_000:10_001]).all() and shard.known.tolist() == [True, False, True]


@pytest.mark.parametrize("copies", [2000, 3])
def test_grammar_leaves_no_frequent_pair(copies):
    """A passage repeated many times becomes a few symbols, and many different pairs leave no rule out."""
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 900, 100)
    ids = np.concatenate([*[passage] * copies, np.tile(rng.permutation(40_000) + 1000, 8), np.full(1001, 7)]).astype("<u4")
    shard = token_store.Shard(token_store.pack([1], [len(ids)], ids, 50_000))
    assert (shard.ids() == ids).all() and (shard.between(150, 99_999) == ids[150:99_999]).all()
    seq, apart = shard.seq.tolist(), collections.Counter()
    at = 0
    while at + 1 < len(seq):
        apart[seq[at], seq[at + 1]] += 1
        at += 2 if at + 2 < len(seq) and seq[at] == seq[at + 1] == seq[at + 2] else 1
    assert max(apart.values(), default=0) < token_store.LEAST
    assert len(seq) < (400 if copies == 3 else 100)


def test_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows, n = [], 0
    for label in (0, 1, None):
        for _ in range(12):
            centre = rng.normal(size=16)
            for _ in range(rng.integers(1, 25)):
                rows.append((n, (centre + rng.normal(scale=0.08, size=16)).tolist(), label))
                n += 1
    good = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] + [1.0] * 15, 1), (n + 3, [float("inf")] * 16, 1), (n + 4, [None] + [1.0] * 15, 0), (n + 5, [], 0), (n + 6, [1.0, 2.0], 0), (None, [1.0] * 16, 0), rows[0]]
    table = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "vec_id long, embedding array<double>, label int, sim int")
    out = {r.vec_id: r for r in embedding_dedup.near_vectors(table, 0.95).collect()}
    assert len(out) == n + 8
    x = np.array([r[1] for r in rows[:good]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = [r[2] for r in rows[:good]]
    link = (x @ x.T >= 0.95) & np.array([[a is not None and a == b for b in lab] for a in lab]) & ~np.eye(good, dtype=bool)
    comp = np.arange(good)
    for a, b in np.argwhere(link):
        comp[comp == max(comp[a], comp[b])] = min(comp[a], comp[b])
    for i in range(good):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (link[i].sum(), comp[i], comp[i] == i)
    for i in range(n, n + 7):
        assert (out[i].n_links, out[i].component_id, out[i].kept) == (0, i, True)
    assert out[None].n_links == 0 and out[None].component_id is None and out[None].kept


def test_vectors_on_a_table_above_the_audit(spark, monkeypatch, tmp_path):
    """Chains of neighbours between groups of copies, compared with the registered SQL; the audit sees few of the vectors."""
    duckdb = pytest.importorskip("duckdb")
    monkeypatch.setattr(embedding_dedup, "AUDIT", 10)
    monkeypatch.setattr(embedding_dedup, "TABLES", 2)
    rng = np.random.default_rng(11)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            v = rng.normal(size=24)
            for _ in range(10):
                v = v + rng.normal(scale=0.14, size=24)
                rows += [(v.tolist(), label)] * 10
    rng.shuffle(order := np.arange(len(rows)))
    rows = [(n, *rows[i]) for n, i in enumerate(order.tolist())]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = sorted(map(tuple, embedding_dedup.near_vectors(table, 0.98).collect()))
    path = str(tmp_path / "embeddings.parquet")
    table.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    want = sorted(con.execute(queries.ORACLE["op1_embedding_neardup"]).fetchall())
    assert len({r[2] for r in want}) < 240 and out == want


def test_audit_finds_what_rounds_left(spark, monkeypatch):
    """Rounds go on while audits find links across groups, and the last addition counts."""
    monkeypatch.setattr(embedding_dedup, "first_pairs", lambda vectors, threshold, seed: spark.createDataFrame([], "a long, b long, sim double"))
    real, turns = embedding_dedup.audit, []

    def one_at_a_time(state, *args):
        share, missed = real(state, *args)
        turns.append(share)
        return share, missed.orderBy("a", "b").limit(1)

    monkeypatch.setattr(embedding_dedup, "audit", one_at_a_time)
    rows = [(2 * k + j, [float(i == k) + 0.01 * j for i in range(5)], 0) for k in range(5) for j in range(2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = sorted(map(tuple, embedding_dedup.near_vectors(table, 0.98).collect()))
    assert out == [(n, 1, n - n % 2, n % 2 == 0) for n in range(10)] and len(turns) == 6 and turns[-1] == 1.0


def test_url_rules_and_aliases(spark):
    link = '<link rel="canonical" href="{}">'.format
    pages = [
        (1, "http://www.example.org/es/1", None), (2, "http://www.example.org/fr/1", link("http://www.example.org/es/1")), (3, "http://other.net/a", link("https://www.example.org/es/1#x")),
        (4, "https://other.net/b?q=1", '<META content="0; url=http://other.net/a" http-equiv="refresh">'), (5, "http://free.net/", link("/self")), (6, None, None), (7, "mailto:x", ""),
        (8, "HTTP://Example.ORG/en/12?x#y", ""), (9, "http://a.com/de/1", ""), (10, "http://a.com/fr/1", ""), (11, "http://notexample.org/es/1", ""), (3, "http://other.net/a", link("https://www.example.org/es/1#x")),
    ]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, rule string")
    out = url_filter.url_verdicts(table, url_filter.rule_table(spark)).collect()
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == len(pages)
    assert found == {
        1: ("www.example.org", "/es/1", "example.org/es/", "block"), 2: ("www.example.org", "/fr/1", "org/", "allow"), 3: ("other.net", "/a", None, "block"), 4: ("other.net", "/b", None, "block"),
        5: ("free.net", "/", None, "allow"), 6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("example.org", "/en/12", "example.org/en/1", "block"), 9: ("a.com", "/de/1", "com/de/", "block"),
        10: ("a.com", "/fr/1", "com/fr/", "allow"), 11: ("notexample.org", "/es/1", "org/", "allow"),
    }


def test_every_form_of_an_alias(spark):
    bad, far = "http://www.example.org/es/x", "http://free.net/d/e/p.html"
    forms = {
        1: '<link rel="canonical" href="/own"><link rel="canonical" href="{}">', 2: '<meta http-equiv=refresh content="1;url=/own"><META HTTP-EQUIV="Refresh" CONTENT="0; URL={}">',
        3: """<meta http-equiv="refresh" content="0; url='{}'">""", 4: """<meta content='0;url="{}"' http-equiv='refresh'>""", 5: "<meta http-equiv=refresh content=0;url={}>",
        6: '<meta http-equiv="refresh" content="0;{}">', 7: "<link href={} rel=canonical>", 8: '<link href="{}" rel="alternate canonical">',
        9: '<link rel="canonical" href=" {}\n">', 10: '<meta http-equiv="refresh" content="0; url=&quot;{}&quot;">',
    }
    pages = [(0, bad, "")] + [(n, f"http://free.net/abs/{n}", h.format(bad)) for n, h in forms.items()]
    names = {20: "next.html", 21: "./next.html", 22: "../e/next.html", 23: "/d/./e/next.html", 24: "//free.net/d/e/next.html", 25: "x/../next.html", 26: "../../../d/e/next.html"}
    pages += [(n, f"{far}?n={n}", f'<link rel="canonical" href="{h}">') for n, h in names.items()]
    pages += [(30, "http://free.net/d/e/next.html", f'<link rel="canonical" href="{bad}">')]
    pages += [(31, "http://free.net/q?a=1", '<link rel="canonical" href="?a=1&amp;b=2">'), (32, "http://free.net/q?a=1&b=2", f"<meta http-equiv=refresh content='0;url={bad}'>")]
    pages += [(33, "http://free.net/based", '<base href="/d/e/"><link rel="canonical" href="next.html">'), (34, "http://free.net", '<link rel="canonical" href="d/e/next.html">')]
    alone = {40: '<link rel="canonical" href="mailto:a@b.co">', 41: '<link rel="non-canonical" href="{}">', 42: '<meta http-equiv="refresh" content="5">', 43: '<link rel="canonical" href="#x">', 44: '<link rel="canonical" href="/r?u={}">', 45: '<link rel="stylesheet" data-rel="canonical" href="{}">'}
    pages += [(n, f"http://alone.net/{n}", h.format(bad)) for n, h in alone.items()]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {r.page_id: r.verdict for r in url_filter.url_verdicts(table, url_filter.rule_table(spark).where("rule_verdict = 'block'")).collect()}
    assert found == {n: "allow" if n >= 40 else "block" for n, *_ in pages}


def test_base_spans_equal_the_patterns():
    rng = random.Random(8)
    pieces = ["a@b.co", "a@b", "@", ".", "x.y@z.a-b.c", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (258) 555-7056", "+12", " ", "-", "é", "12", "\n", "b+c@d.e@f.g"]
    for _ in range(500):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))
        want = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub(r"[ -]", "", m[0])
            if 13 <= len(d) <= 19 and pii.luhn(d):
                want.append(("card", *m.span()))
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        assert pii.base_spans(t) == want, t


def test_field_adds_spans_and_keeps_base(spark, corpus):
    texts = ["call (258) 555-7056 now", "mail bob at example dot com please", "a@b.co and 1.2.3.4", "the year 2024-01-02 and v1.2.3", None, ""]
    docs = docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)] + corpus)
    field = pii.train(pii.labelled_table(spark, docs))
    out = {r.doc_id: r for r in pii.personal_data_report(docs, field).where("doc_id < 6").collect() if r.spans or r.doc_id > 2}
    assert out[0].spans == "phone:5:19" and out[1].spans == "email:5:27" and out[2].spans == "email:0:6,ip:11:18"
    assert out[2].base_sha256 == hashlib.sha256(b"email:0:6,ip:11:18").hexdigest() and out[3].spans == ""


def credible_spans(text, field):
    return [(k, int(a), int(b)) for k, a, b in pii.field_spans([text], field)[0] if pii.credible(k, text[a:b])]


def test_field_on_held_out_and_hand_labelled_lines_and_the_filter_of_lines(spark, corpus, monkeypatch):
    docs = docs_of(spark, corpus)
    field = pii.train(pii.labelled_table(spark, docs))
    held_out = pii.labelled_table(spark, docs, lines=150, seed=1234)
    made = pii.quality(field, held_out)
    assert made["precision"] >= 0.9 and made["recall"] >= 0.85
    by_hand = [
        ("my number is (212) 555-0147, ring me", [("phone", 13, 27)]), ("reach anna at posteo dot net any time", [("email", 6, 28)]),
        ("server 10[.]0[.]200[.]7 was down", [("ip", 7, 23)]), ("built 2023-11-05, version 4.2.1, price $12.50", []),
        ("see page 12 of 340 at noon. Then rest", []), ("card 4111.1111.1111.1111 expired", [("card", 5, 24)]),
    ]
    got = pii.quality(field, spark.createDataFrame(by_hand, held_out.schema))
    assert got["precision"] >= 0.8 and got["recall"] >= 0.8
    texts = [r["line"] for r in held_out.collect()] + [t for _, t, _ in corpus if t and len(t) < 5000] + ["a\n1 2\n3.4", "1\n.2.\n3.4", "x at\ny.z", "1_2_3_4", "thatx.y at q", "٣ 1 2 3 4"]
    found = [credible_spans("\n".join(texts[k:k + 7]), field) for k in range(0, len(texts), 7)]
    monkeypatch.setattr(pii, "maybe_lines", lambda t: [(m.start(), m.end()) for m in re.finditer(r"[^\n]+", t)])
    assert found == [credible_spans("\n".join(texts[k:k + 7]), field) for k in range(0, len(texts), 7)]


def test_personal_data_anywhere_in_a_line(spark, corpus):
    """At any place of a long line, and where an address has a point and no other sign; filtered lines hold nothing credible."""
    lone = ["write to bob at example.com today", "please call (258) 555-7056 now"]
    texts = [f"{'word ' * k}call (258) 555-7056 {'word ' * 600}" for k in range(500, 514)] + lone
    docs = docs_of(spark, [(i, t, "a") for i, t in enumerate(texts)])
    field = pii.train(pii.labelled_table(spark, docs_of(spark, corpus)))
    out = {r.doc_id: r.spans for r in pii.personal_data_report(docs, field).collect()}
    assert [out[i] for i in range(14)] == [f"phone:{5 * k + 5}:{5 * k + 19}" for k in range(500, 514)]
    assert out[14] == "email:9:27" and out[15] == "phone:12:26"
    for piece in ("bob at example.com", "BOB AT EXAMPLE DOT COM", "a[at]b[dot]co", "a@b.co", "1.2.3.4", "4111 1111 1111 1111"):
        assert list(pii.maybe_lines(f"a b\nx {piece} y\nc")) == [(4, 8 + len(piece))]


def page(body, tail=""):
    return f"<html><head><title>t</title><script>var a='<p>x</p>'</script></head><body><nav><a href=/>Home</a></nav>{body}<footer>&copy; us</footer>{tail}</body></html>"


def test_article_text(spark):
    rng = random.Random(6)
    article = lambda: "<article><h1>{}</h1>{}</article>".format(words(rng, 5), "".join(f"<p><b>{words(rng, 30)} &amp; {words(rng, 9)}<br>\n<p>{words(rng, 40)}</p>" for _ in range(4)))
    sources = [page(f'<div class="ad">{words(rng, 8)}</div>' + article()) for _ in range(60)]
    sources += [None, "", "<p", page(""), page(article())[:400], page('<div class="cookie-notice"><p>' + words(rng, 9) + "</p></div>" + article() + '<div class="comments"><p>' + words(rng, 20) + "</p></div>")]
    table = spark.createDataFrame([(i, f"http://x/{i}", s, "t") for i, s in enumerate(sources)], "page_id long, url string, html string, text string")
    out = sorted(html_extract.main_text(table, html_extract.train(table)).collect(), key=lambda r: r.page_id)
    assert len(out) == len(sources)
    for r, s in zip(out, sources):
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", s or "", re.S)
        want = " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>?", " ", m[1]).replace("<b>", "")).split()) if m else ""
        assert (r.text, r.n_chars) == (want, len(want)), r.page_id


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(9)
    bad = ["vilex", "grubby", "snorkt", "plimp"]
    rows, labels = [], []
    for i in range(700):
        text, toxic = words(rng, rng.randint(5, 60)), int(i % 5 == 0)
        if toxic:
            text += f" you {rng.choice(bad)} {rng.choice(bad)} " + words(rng, 4)
        rows.append((i, text, "a"))
        labels.append((i, toxic))
    rows += [(9000, None, "a"), (9001, "", "a"), (None, "grubby vilex", "a"), (1, rows[1][1], "a")]
    table = spark.createDataFrame(labels + [(5, None), (8888, 1)], "doc_id long, toxic int")
    docs = docs_of(spark, rows)
    model = toxicity.train(docs, table)
    out = model.score(docs).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    truth = dict(labels)
    held = [(r.predicted, truth[r.doc_id]) for r in out if r.held_out and r.doc_id in truth]
    assert sum(p == y for p, y in held) / len(held) > 0.95
    kept = model.keep(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes and kept.count() == sum(1 - r.predicted for r in out)


def test_toxicity_without_both_classes(spark):
    docs = docs_of(spark, [(0, "a b", "a"), (1, "c d", "a"), (3, "e", None)])
    for labels, share in (([], 0.0), ([(0, 1), (1, 1), (3, 1)], 1.0)):
        table = spark.createDataFrame(labels, "doc_id long, toxic int")
        assert {r.score for r in toxicity.train(docs, table).score(docs).collect()} == {share}


def test_empty_tables(spark):
    docs, pages = docs_of(spark, []), spark.createDataFrame([], "page_id long, url string, html string")
    items, vectors = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert minhash_dedup.near_duplicates(docs).count() == 0
    assert suffix_dedup.without_repeats(docs).count() == 0
    assert decontaminate.contamination(docs, items).count() == 0
    assert mixing.mixture(docs).count() == 0 and mixing.mixed(docs).count() == 0
    assert embedding_dedup.near_vectors(vectors).count() == 0
    assert url_filter.url_verdicts(pages, url_filter.rule_table(spark)).count() == 0
    assert html_extract.main_text(pages, html_extract.train(pages)).count() == 0
    assert pii.personal_data_report(docs, pii.train(pii.labelled_table(spark, docs))).count() == 0
    tokens = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    assert token_store.token_table(docs, tokens).count() == 0


def test_spelled_addresses_take_time_in_proportion():
    """The same pieces as one pattern names, which tries all ways to share out a space and did not end on long spans."""
    import random
    import re
    import time

    pattern = re.compile(r"[\w.%+-]+\s*[\[(]?\s*(?:@|at)\s*[\])]?\s*[\w-]+(?:\s*[\[(]?\s*(?:\.|dot)\s*[\])]?\s*[\w-]+)+", re.I)
    rng, parts, found = random.Random(5), ["a", "at", "dot", "AT", "Dot", "@", ".", " ", "[", "]", "(", ")", "-", "%", "\n", "\u00f1", "1"], 0
    for _ in range(20_000):
        piece = f"a{rng.choice([' ', ''])}{rng.choice(['at', '@', '(at)'])}{rng.choice([' ', ''])}" + "".join(rng.choices(parts, k=rng.randint(0, 8)))
        assert pii.spelled_address(piece) == (pattern.fullmatch(piece) is not None), piece
        found += pii.spelled_address(piece)
    assert found > 100
    began = time.process_time()
    for piece in ("attith. " * 200 + "atti", "hationer. " * 5000 + "!", "a at " + "dot" * 5000 + "!", "a" + " " * 5000 + "!"):
        pii.spelled_address(piece)
        list(pii.maybe_lines(piece))
    assert time.process_time() - began < 5


def test_blocks_of_one_component_do_not_meet(spark, monkeypatch):
    """Rows grow with a bucket, not with its square, where one component holds most of it; pairs across all meet once."""
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    comps = {i: 0 if i < 400 else i for i in range(410)}
    rows = spark.createDataFrame([(7, i, c) for i, c in comps.items()], "key long, id long, comp long")
    dealt = minhash_dedup.block_pairs(rows).collect()
    assert len(dealt) == 400 + 10 * (1 + 25)
    met = collections.defaultdict(lambda: collections.defaultdict(list))
    for r in dealt:
        met[r.i, r.j][r.own].append(r.id)
    pairs = collections.Counter()
    for (i, j), blocks in met.items():
        pairs.update({(min(x, y), max(x, y)) for x in blocks[i] for y in blocks[j] if comps[x] != comps[y]})
    wanted = {(x, y) for x in comps for y in comps if x < y and comps[x] != comps[y]}
    assert set(pairs) == wanted and set(pairs.values()) == {1}


def test_op5_pieces_of_bytes_are_those_of_the_tokenizers_pattern():
    """Letters, single digits, other signs and contractions, found in bytes without a pattern; ids are the library's."""
    import random
    import re

    import numpy as np

    from bedwise.llm import token_store
    from bedwise.llm.queries import tokenizer_path

    pattern = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[!-/:-@\[-`{-~]+")
    chance = random.Random(5)
    texts = ["".join(chance.choice("aestrvlmd'' !\"01\n\x0b\tß\xe9À~`ZS") for _ in range(chance.randrange(30))) for _ in range(2000)]
    texts += ["", "'", "'S", "'re've", "a'", "'ll'd'street", "12345678", "abcdefgh abcdefghi", "一 'İs", "x" * 20]
    for text in texts:
        raw = text.lower().encode() + b"\n"
        found = [raw[a:b].decode() for a, b in zip(*token_store.piece_spans(np.frombuffer(raw, np.uint8)))]
        assert token_store.is_odd(text) or found == pattern.findall(text.lower())
    encoder = token_store.WordEncoder(tokenizer_path())
    assert encoder.encode(texts) == encoder._encode(texts) and encoder.encode([]) == []
