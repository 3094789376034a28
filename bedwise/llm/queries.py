"""Registered queries of this folder, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bedwise.llm import (
    decontaminate, embedding_dedup, fill_middle, html_extract, importance, minhash_dedup, mixing, permutation_index, pii, suffix_dedup, token_store, toxicity, url_filter,
)
from bedwise.llm.common import ship

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship(spark)
            return build(spark, sf)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return build

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), link AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e)
  WHERE list_cosine_similarity(x.e, y.e) >= 0.98
), reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, link.b FROM reach JOIN link ON reach.r = link.a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN n ON a = vec_id JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) ON id = vec_id
"""


@query("op1_embedding_neardup", EMBEDDING_SQL)
def _(spark, sf):
    return embedding_dedup.near_vectors(table(spark, sf, "embeddings"), threshold=0.98)


@query("op2_toxicity")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return toxicity.train(docs, table(spark, sf, "labels")).score(docs)


URL_SQL = r"""
WITH RECURSIVE rules(rule_host, rule_path, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
p AS (
  SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, url, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)
), adr AS (
  SELECT *, regexp_replace(host, ':(80|443)$', '') || CASE WHEN starts_with(tail, '/') THEN tail ELSE '/' || tail END AS adr
  FROM (SELECT *, regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS tail FROM p)
), best AS (
  SELECT page_id, arg_max(rule_host || rule_path, length(rule_host) * 100000 + length(rule_path)) AS rule, arg_max(v, length(rule_host) * 100000 + length(rule_path)) AS v
  FROM adr JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
), target AS (
  SELECT adr AS a, unnest([regexp_extract(html, '(?is)<link\b[^>]*\bcanonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1), regexp_extract(html, '(?is)<meta\b[^>]*\brefresh\b[^>]*url\s*=\s*([^"''\s>]+)', 1)]) AS u FROM adr
), edge AS (
  SELECT a, translate(regexp_extract(u, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || coalesce(nullif(regexp_extract(u, '://[^/?#]*([^#]*)', 1), ''), '/') AS b
  FROM target WHERE contains(u, '://')
), near AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
bad AS (SELECT DISTINCT adr FROM adr JOIN best USING (page_id) WHERE v = 'block' UNION SELECT near.b FROM bad JOIN near ON bad.adr = near.a)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN bad.adr IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM adr LEFT JOIN best USING (page_id) LEFT JOIN bad USING (adr)
"""


@query("op4_url_filter", URL_SQL)
def _(spark, sf):
    return url_filter.url_verdicts(table(spark, sf, "pages"), url_filter.rule_table(spark))


@query("op5_token_store")
def _(spark, sf):
    return token_store.token_table(table(spark, sf, "documents"), tokenizer_path())


LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(""" + LOWERED.format("text") + r""", '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS r FROM documents UNION SELECT reach.id, both_ways.b FROM reach JOIN both_ways ON reach.r = both_ways.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id
"""


@query("op3_minhash", MINHASH_SQL)
def _(spark, sf):
    return minhash_dedup.near_duplicates(table(spark, sf, "documents"), percent=85)


SUFFIX_SQL = r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM t WHERE length(h) >= 400)),
again AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w SEMI JOIN again USING (k)),
run AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit) GROUP BY doc_id, g),
gap AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM run),
part AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head, max(b) AS last FROM gap JOIN t USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN part USING (doc_id)
"""


@query("op6_suffix_dedup", SUFFIX_SQL)
def _(spark, sf):
    return suffix_dedup.without_repeats(table(spark, sf, "documents")).drop("kept")


@query("op7_html_extract")
def _(spark, sf):
    pages = table(spark, sf, "pages")
    return html_extract.main_text(pages, html_extract.train(pages))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS o
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1) AS weight FROM d GROUP BY source
), ranked AS (
  SELECT *, sum(source_size) OVER ()::BIGINT AS total, count(*) OVER () AS sources,
    (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::BIGINT AS room,
    (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::BIGINT AS open
  FROM s WINDOW before AS (ORDER BY source_size / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), flagged AS (SELECT *, 3 * source_size * open <= weight * room AS filled FROM ranked),
line AS (SELECT room, open FROM flagged WHERE NOT filled ORDER BY source_size / weight, encode(source) NULLS LAST LIMIT 1),
t AS (
  SELECT source, source_size, total, CASE WHEN filled THEN (3 * source_size)::DOUBLE
    ELSE (weight * (SELECT room FROM line)) / (SELECT open FROM line) END AS target FROM flagged
), q AS (
  SELECT *, count(*) OVER () AS n_sources, greatest(1, least(2048, floor(min(target) OVER () / 1000)))::BIGINT AS block FROM t WHERE source_size > 0
), h AS (SELECT *, unnest(range(0, 16)) AS shard FROM q),
seats AS (SELECT *, floor(round(total / block) * (shard + 1) / 16)::BIGINT AS seats FROM h),
near AS (SELECT *, seats * target / total AS share, (seats * target / total) * n_sources / (2 * greatest(seats, 1)) AS slack FROM seats),
bounds AS (SELECT *, greatest(0, floor(share - slack - 1))::BIGINT AS low, ceil(share + slack + 1)::BIGINT AS high FROM near),
seat AS (SELECT *, unnest(range(low, high + 1)) AS seat FROM bounds),
placed AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY target / (2 * seat + 1) DESC, encode(source) NULLS LAST, seat) AS place FROM seat),
won AS (
  SELECT source, shard, max(low) + sum(CASE WHEN place <= seats - sure THEN 1 ELSE 0 END) AS upto
  FROM placed JOIN (SELECT shard, sum(low) AS sure FROM bounds GROUP BY shard) USING (shard) GROUP BY ALL
), quota AS (SELECT source, max(upto)::BIGINT AS quota, list(upto ORDER BY shard) AS ends FROM won GROUP BY source),
plan AS (
  SELECT t.source, t.source_size, t.target, least(coalesce(quota * block, 0), 3 * t.source_size)::BIGINT AS words,
    coalesce(('0x' || substr(md5('42:' || coalesce(t.source, '')), 1, 12))::BIGINT % ceil(t.source_size / block)::BIGINT * block, 0)::BIGINT AS start, block, ends
  FROM t LEFT JOIN quota ON t.source IS NOT DISTINCT FROM quota.source LEFT JOIN q ON t.source IS NOT DISTINCT FROM q.source
), r AS (
  SELECT doc_id, size, plan.source_size, target, start, block, ends,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off,
    CASE WHEN plan.source_size > 0 THEN words // plan.source_size ELSE 0 END AS passes, words
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source
)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN len(list_filter(ends, lambda e: e * block <= CASE WHEN off >= start THEN off - start WHEN off + size > start THEN 0 ELSE off + source_size - start END)) END::INTEGER AS shard FROM (
SELECT doc_id, size, source_size, target, start, block, ends, off, (passes * size
  + greatest(0, least(size, start + words - passes * source_size - source_size - off))
  + greatest(0, least(size, least(start + words - passes * source_size, source_size) - off) - greatest(0, start - off)))::BIGINT AS taken
FROM r)
"""


@query("op8_mixing", MIX_SQL)
def _(spark, sf):
    return mixing.mixture(table(spark, sf, "documents"))


@query("op9_pii")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    return pii.personal_data_report(docs, pii.train(pii.labelled_table(spark, docs)))


DECONTAMINATE_SQL = r"""
WITH iw AS (
  SELECT item_id, regexp_extract_all(""" + LOWERED.format("text") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, w[i:i + least(13, len(w)) - 1] AS win FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, regexp_extract_all(""" + LOWERED.format("text") + r""", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (SELECT DISTINCT len(win) AS n FROM win),
dwin AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes)),
met AS (SELECT doc_id, i, n, item_id FROM dwin JOIN win USING (win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""


@query("op10_decontaminate", DECONTAMINATE_SQL)
def _(spark, sf):
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("tid")


@query("op11_importance_resampling")
def _(spark, sf):
    return importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark")).drop("n_words")


@query("op12_permutation_index")
def _(spark, sf):
    return permutation_index.nearest(table(spark, sf, "embeddings"), top=20, every=20)


FILL_SQL = r"""
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), k AS (
  SELECT *, len(u) AS n, ('0x' || substr(x, 1, 8))::BIGINT AS h1, ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM h
), c AS (
  SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
    least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM k
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


@query("op13_fill_middle", FILL_SQL)
def _(spark, sf):
    return fill_middle.digests(table(spark, sf, "documents"))
