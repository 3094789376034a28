import importlib.util
import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


@pytest.mark.parametrize("name", ["op1_embedding_neardup", "op3_minhash", "op4_url_filter", "op6_suffix_dedup", "op8_mixing", "op10_decontaminate"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    spec = importlib.util.spec_from_file_location("check_oracle", os.path.join(ROOT, "scripts", "check_oracle.py"))
    check = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(check)
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert check.compare(entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])) == []


def test_every_stage_keeps_the_columns_and_the_last_covers_its_input(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
            docs = out
        sizes.append(out.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] > 0 and sizes[5] == sizes[4]
    ids = out.orderBy("start").collect()
    assert [r.doc_id for r in ids] == sorted(r.doc_id for r in ids)
    assert all(a.start + a.n_tokens == b.start for a, b in zip(ids, ids[1:]))


def stage(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row_key long, tid string, component_id int, comp int"


def rows_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 7, "t", 1, 2) for i, t in rows], COLUMNS)


def test_near_duplicates_are_decided_by_text(spark):
    """Ids that several texts share, null ids, repeated rows, texts without a word."""
    a = " ".join(f"word{k}" for k in range(60))
    near = a.replace("word59", "other")
    b, c = " ".join(f"else{k}" for k in range(40)), " ".join(f"third{k}" for k in range(40))
    rows = [(2, a), (1, a), (2, b), (None, a), (3, near), (3, near), (None, c), (None, c), (5, c + " end"), (7, None), (7, None), (8, ""), (None, " \n"), (9, "one"), (9, "two"), (10, "two")]
    docs = rows_of(spark, rows)
    found = stage("minhash_near_dedup")(spark, docs, SF)
    assert found.columns == docs.columns
    kept = sorted((r["doc_id"], r["text"]) for r in found.where("text IS NOT NULL AND doc_id IS NOT NULL").collect())
    assert kept == sorted([(1, a), (2, b), (5, c + " end"), (8, ""), (9, "one"), (9, "two")])
    assert found.where("text IS NULL").count() == 2 and found.where("doc_id IS NULL").count() == 1


def test_copies_do_not_meet_every_partner_of_their_text(spark, monkeypatch):
    """The join of pairs with full sets makes as many rows as there are pairs, however often a text is repeated."""
    from bedwise.llm import minhash_dedup

    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[:k] + ["other"] + words[k + 1:]) for k in range(0, 120, 10)]
    rows = [(i, t) for i, t in enumerate([" ".join(words)] * 60 + texts + [texts[3]] * 30 + ["a b c", "a b c"])]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    most, drop = [], minhash_dedup.drop_table

    def dropped(spark, table):
        if "grams" in table.columns:
            most.append(max(r["count"] for r in table.groupBy("id").count().collect()))
        drop(spark, table)

    monkeypatch.setattr(minhash_dedup, "drop_table", dropped)
    found = {r.doc_id for r in stage("minhash_near_dedup")(spark, docs, SF).collect()}
    assert most and set(most) == {1}
    assert found == {0, 102}


def test_stages_of_empty_tables(spark):
    empty = rows_of(spark, [(1, "x")]).limit(0)
    for name in ("toxicity", "minhash_near_dedup", "benchmark_decontamination", "source_mixing", "token_files"):
        assert stage(name)(spark, empty, SF).count() == 0


def test_decontamination_keeps_clean_rows_with_the_same_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    clean = " ".join(f"word{k}" for k in range(60))
    found = stage("benchmark_decontamination")(spark, rows_of(spark, [(1, item), (1, clean), (None, item), (None, clean), (2, None)]), SF)
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in found.collect()) == [("1", clean), ("2", ""), ("None", clean)]
